"""Compositions: input bindings, the medallion run, ad-hoc SQL and the registered queries."""
