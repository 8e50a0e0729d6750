"""Training-data operators: search, near duplicates, mixing, packing, extraction, filters.

Every module here holds one operator with a general interface; ``queries`` binds
them to the registered ``opN_<name>`` contracts.  Nothing outside this subpackage
imports it.
"""
