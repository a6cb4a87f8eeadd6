"""quernstone: a PySpark-native analytics engine.

The package is organised by what a query needs: ``session`` pins the SQL
dialect, ``functions`` holds the typed scalar library, ``operators`` the
relational building blocks, ``sources`` readers and writers, ``streaming`` the
continuously updated tables and ``plans`` the registered queries.
"""
