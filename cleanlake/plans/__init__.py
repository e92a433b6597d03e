"""Jobs made of the operators: plan a clean-up, report it, apply it; run a storage scan."""
