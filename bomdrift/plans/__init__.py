"""Jobs: build the model, publish tables, log loads, export grids."""
