"""Second-order operators on DataFrames. All are lazy and global unless a name says otherwise."""

from weirflow.operators.aggregate import fold, fold_ordered, group_runs, hash_fold, map_group, min_record_by, monoid
from weirflow.operators.exchange import broadcast_if_small, hash_partition, range_partition, round_robin
from weirflow.operators.joins import hash_join, merge_join
from weirflow.operators.setops import difference, distinct, union_all
from weirflow.operators.sort import sort, sort_within_partitions, top_k, with_positions
from weirflow.operators.state import update_existing, upsert
from weirflow.operators.transforms import filter_rows, flat_map, map_partitions, map_rows, map_with_broadcast

__all__ = [
    "broadcast_if_small", "difference", "distinct", "filter_rows", "flat_map", "fold", "fold_ordered", "group_runs", "hash_fold", "hash_join", "hash_partition",
    "map_group", "map_partitions", "map_rows", "map_with_broadcast", "merge_join", "min_record_by", "monoid", "range_partition", "round_robin", "sort", "sort_within_partitions", "top_k",
    "union_all", "update_existing", "upsert", "with_positions",
]
