"""Operators for preparing training text: ten operators, each in a module of
its own, their registered queries (``queries.py``) and shared helpers
(``text.py`` vectorised word tools, ``stages.py`` written stages,
``graph.py`` connected components). Nothing else in the library imports
this subpackage."""
