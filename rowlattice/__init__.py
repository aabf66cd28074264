"""rowlattice: comparing, checking, compacting and reshaping tables with Spark."""
