"""Training-data operators: cleaning, matching, scoring and mixing large text corpora.

Each module holds one operator with its general interface; ``queries``
registers the thin ``opN_<name>`` queries over the test tables.  Nothing else
in the library imports this subpackage.
"""
