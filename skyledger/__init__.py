"""skyledger: calibration and validation of large measurement catalogs on Spark.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); the layout is

* ``functions``  column expressions (guards, residuals, likelihoods, sky maths)
* ``operators``  DataFrame plans (robust statistics, joins, fits, scoring)
* ``sources``    readers, writers and model tables
* ``streaming``  Structured Streaming jobs
* ``plans``      the registered queries over the driver's test tables
"""

__version__ = "0.1.0"
