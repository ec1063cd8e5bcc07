"""Plan helpers shared by the operators: table access and lineage cuts."""
