"""Table operators: relational steps, ordered windows, encoders, profiles, tests."""
