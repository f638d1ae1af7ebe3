"""Part of veilframe; see the README for a map of the package."""
