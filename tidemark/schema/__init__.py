"""The schema language: declarations of events, values, aggregates, states and read models."""
