"""Claim analytics on Spark: snapshots, identity, consensus, existence and maps over an append-only fact log."""
