"""Corpus-scale analytics over speaker-labelled meeting transcripts, on Spark DataFrames."""
