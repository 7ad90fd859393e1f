"""Named queries over the given tables, each paired with its SQL check where SQL can say it."""
