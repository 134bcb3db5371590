"""chromalith.functions"""
