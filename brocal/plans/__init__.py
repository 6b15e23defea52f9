"""Registered queries: each module has QUERIES, and SQL where SQL can say the same."""

MODULES = ("brocal.plans.problems", "brocal.plans.social", "brocal.plans.streams", "brocal.plans.graphs", "brocal.plans.prep", "brocal.plans.corpus", "brocal.plans.models")
