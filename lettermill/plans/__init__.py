"""lettermill.plans"""
