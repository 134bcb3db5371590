"""chromalith.sources"""
