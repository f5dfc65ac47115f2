"""extracteval: Spark operators that evaluate and prepare structured-extraction data.

Everything is ``DataFrame -> DataFrame`` or ``Column -> Column``; see README.md
for the data model and for how each operator behaves on skewed, very large input.
"""

__version__ = "0.1.0"
