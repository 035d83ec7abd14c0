"""Plans over operators: iteration, dataflow graphs and complete workloads."""

from weirflow.plans.graph import Graph
from weirflow.plans.iterate import iterate
from weirflow.plans.workloads import k_means, least_record_per_key

__all__ = ["Graph", "iterate", "k_means", "least_record_per_key"]
