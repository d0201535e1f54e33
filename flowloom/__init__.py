"""Origin-destination flow analytics on Spark."""

from .frame import FlowFrame, concat, describe
from .operators.cluster import DBSCANFlow, KMedoidFlow, dbscan, kmedoid
from .operators.manifold import FTSNE
from .operators.pairs import eps_pairs, k_neighbor_distances, pairwise_distances, snn_distance
from .operators.stats import flow_divergence, flow_entropy, k_func, l_func, local_l_func, second_order_density
from .operators.zones import i_index, spatial_join, to_grid
from .scalar import Flow
from .sources.tables import flows_from_geometry, flows_from_od, flows_from_wkt, read_csv
from .sources.vector import read_file, to_file

__all__ = [
    "FTSNE", "DBSCANFlow", "Flow", "FlowFrame", "KMedoidFlow", "concat", "dbscan", "describe", "eps_pairs",
    "flow_divergence", "flow_entropy", "flows_from_geometry", "flows_from_od", "flows_from_wkt", "i_index", "k_func",
    "k_neighbor_distances", "kmedoid", "l_func", "local_l_func", "pairwise_distances", "read_csv", "read_file",
    "second_order_density", "snn_distance", "spatial_join", "to_file", "to_grid",
]
