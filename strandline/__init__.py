"""Time-series measurement analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames.  A series is named by key
columns, its order by a timestamp plus a tie-break column, and nothing in the
package depends on the physical order of rows.
"""

from strandline.session import configure

__all__ = ["configure"]
