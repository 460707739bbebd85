"""Bookings and web-traffic analytics as Spark DataFrame jobs."""
