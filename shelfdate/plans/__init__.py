"""Whole plans: tokens to dates, and the reading ladder."""
