"""chromalith.plans"""
