"""Planning on the driver: session state, profiles of columns, banner plans, chart specs."""
