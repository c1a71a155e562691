"""mailshift: mailbox-configuration analytics on Spark.

Turns many mailbox exports (message archives, filter-rule feeds) into tables
for planning a move to another mail provider.  Every public function takes and
returns a ``DataFrame`` or a ``Column``; the heavy lifting is Catalyst
expressions, joins, windows and aggregations.
"""

__all__ = ["session", "constants"]
