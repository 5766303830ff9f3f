"""Reading raw payloads and writing results."""
