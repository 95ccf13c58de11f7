"""Queries: the operators applied to the test tables, each with its SQL form where there is one."""
