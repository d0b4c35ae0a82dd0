"""Layer-boundary uncertainty on Spark: DataFrame operators for variance maps, kriging and stacking.

The names of ``_PUBLIC`` are the public surface; each is imported from its module on first use.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

_PUBLIC = {
    "functions.expressions": ["compile_expr"],
    "functions.kernels": ["available_certainty_functions", "certainty_function", "register_certainty_function", "well_kernel"],
    "operators.clean": ["dedup_keep_last", "resolve_doi", "temporal_filter", "wide_to_layers"],
    "operators.clusters": ["build_zones", "cluster_range_sill", "cluster_stats", "som_cluster_grid", "split_oversized"],
    "operators.combine": ["apply_floor", "combine_variances", "constant_prior", "informed_mask", "minimum_map", "model_theme", "stack"],
    "operators.grid": ["GridMeta", "import_classes", "mosaic", "sample_at"],
    "operators.kriging": ["blend", "buffer_weights", "build_windows", "connected_components", "krige", "simulate_layers"],
    "operators.nearest": ["nearest_n", "windowed_nearest"],
    "operators.points": ["draw_points", "draw_probability", "sample_cells", "transfer"],
    "operators.rangesill": ["NetworkEstimator", "VariogramEstimator", "estimate_at", "estimate_centre", "estimate_surface", "train_estimator"],
    "operators.stacking": ["add_bottom", "clamp_to_upper", "merge_layers", "perturb_realization", "stack_realizations", "tie_realizations"],
    "operators.themes": ["ThemeSpec", "available_theme_specs", "build_theme", "dump_spec", "load_spec", "resolve_theme_spec"],
    "operators.wells": ["build_well_theme", "prepare_wells", "tie_map"],
    "session": ["local_session"],
    "sources.bundles": ["RegionConfig", "load_theme_data", "read_layer_tables", "read_points"],
    "sources.rasters": ["load_grid", "perturb_layer_boundaries", "read_variance_stack", "write_display_stack", "write_layers", "write_variance_stack"],
    "streaming.precision": ["running_combination"],
}
_MODULE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"lithoflow has no name {name!r}")
    return getattr(import_module(f"lithoflow.{_MODULE[name]}"), name)
