"""Readers and writers of networks and itinerary stores."""
