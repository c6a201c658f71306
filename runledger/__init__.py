"""Batch and streaming analytics over build-run logs, task graphs, content
fingerprints, release inventories and changelogs, written on Spark DataFrames."""
