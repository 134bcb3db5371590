"""chromalith.operators"""
