"""lettermill.functions"""
