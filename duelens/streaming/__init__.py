"""The record stream."""
