"""stopwise.sources"""
