"""Column expressions: text, facts, rules, rewards, judge output, vectors, statistics."""
