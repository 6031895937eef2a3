"""stopwise.streaming"""
