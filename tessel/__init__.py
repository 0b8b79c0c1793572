"""tessel — corpus preparation, auditing and classification as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (or a Column
expression) that stays lazy: nothing is collected to the driver, so Catalyst
plans the whole chain and the work is distributed across executors.
"""

__version__ = "0.1.0"
