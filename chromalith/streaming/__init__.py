"""chromalith.streaming"""
