"""Streams of departures and feed rows; the batch operators serve both."""
