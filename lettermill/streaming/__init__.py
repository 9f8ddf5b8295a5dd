"""lettermill.streaming"""
