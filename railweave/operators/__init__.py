"""Operators over trains, stops, stations, networks and routes."""
