"""Readers of workbooks and pages."""
