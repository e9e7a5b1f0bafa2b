"""Column functions: times, numbers, texts, people. All are Catalyst expressions."""
