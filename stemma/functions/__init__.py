"""Column expressions: text clean-up, SQL rules, change texts, replies, scores."""
