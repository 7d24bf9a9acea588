"""Registered queries over the whole tables, with the SQL that an oracle runs."""
