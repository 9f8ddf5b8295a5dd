"""lettermill.sources"""
