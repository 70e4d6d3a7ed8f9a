"""Following deliveries as they arrive."""
