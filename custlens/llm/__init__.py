"""Operators for preparing training corpora.  Nothing outside this folder
imports it; each module holds one operator and ``queries`` binds them to the
benchmark tables."""
