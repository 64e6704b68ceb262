"""Compositions: snapshots, the service, evaluation, and the registered queries."""
