"""Operators over whole tables: joins by similarity, ranking, planning, counting."""
