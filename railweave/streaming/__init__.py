"""Live changes of an itinerary store."""
