"""Training-data operators: extraction, deduplication, scoring, tokenising and scanning.

The package stands alone: nothing outside it imports it, and it imports nothing
from the causal engine.  ``registry`` holds the driver queries and their SQL.
"""
