"""Shares the session of the tests above."""
