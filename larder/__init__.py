"""larder: stock and task analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and plain Python parameters such as the
reference date ``as_of`` or the job time ``now``) and returns DataFrames. Nothing is
collected to the driver inside an operator.
"""

__version__ = "0.1.0"
