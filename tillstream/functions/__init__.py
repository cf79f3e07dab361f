"""Column helpers; none of them needs a UDF."""
