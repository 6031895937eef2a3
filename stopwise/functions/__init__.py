"""stopwise.functions"""
