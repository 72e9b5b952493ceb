"""Streams of events: state that is kept by key, and tables that are brought up to date batch by batch."""
