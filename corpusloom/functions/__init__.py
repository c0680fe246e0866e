"""Column expressions: encoders, numeric reductions, schedules."""
