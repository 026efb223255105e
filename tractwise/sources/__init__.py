"""Readers and writers for histogram, delta-series and FASTA files."""
