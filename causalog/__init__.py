"""Causal operation-log analytics on Spark DataFrames.

An operation log holds add/remove operations on registers, sets, maps, counters
and lists.  Every row names its writing site and carries a vector clock (``lts``)
and a hybrid logical clock (``pts``).  The library computes what such a log
means *now* and keeps every step a lazy DataFrame plan wherever Spark allows it.
"""
