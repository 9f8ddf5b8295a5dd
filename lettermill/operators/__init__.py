"""lettermill.operators"""
