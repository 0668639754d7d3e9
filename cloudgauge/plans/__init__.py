"""The scoring plans: completeness, accuracy, F1 and what is written of them."""
