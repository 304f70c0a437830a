"""Typed tables from inconsistent documents, and declarative aggregate queries over them, as Spark plans."""
