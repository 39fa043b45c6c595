"""Registered queries: one callable per operator, with the SQL that checks it."""
