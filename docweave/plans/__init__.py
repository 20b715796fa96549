"""Queries over the test tables, each with DuckDB SQL for the same rows where SQL can say it.

Every module has QUERIES: name -> (function of (spark, sf_dir), SQL or None). Names begin with
the operators' ids in the inventory.
"""
