"""Readers and writers: result trees, FASTA, Newick, delimited files."""
