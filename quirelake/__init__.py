"""quirelake: a Spark-native engine over the structure of PDF files.

Bytes become rows once, in Arrow kernels (``quirelake.sources`` and
``quirelake.functions``); everything after that is DataFrame work
(``quirelake.operators``, ``quirelake.plans``).
"""
