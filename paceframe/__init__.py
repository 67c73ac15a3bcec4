"""paceframe: athlete-state analytics as Spark DataFrame transformations.

Every table is keyed by ``athlete_id`` and ``date``; a daily table holds at
most one row per athlete and calendar day, so an athlete's history is bounded
by the calendar (about 365 rows a year) however many raw records fed it.
"""
