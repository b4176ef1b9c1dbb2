"""Column predicates of the validation rules."""
