"""End-to-end plans composed from operators (features, scoring, training)."""
