"""Jobs composed of operators: retrieval, index sync, catalogue, state tables."""
