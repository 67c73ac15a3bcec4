"""Readers of wearable exports and writers of result tables."""
