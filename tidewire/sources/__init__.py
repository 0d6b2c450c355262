"""Tables and the packet projections over them."""
