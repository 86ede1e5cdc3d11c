"""Readers for corpora, splits and contracts; writers for result tables and ledgers."""
