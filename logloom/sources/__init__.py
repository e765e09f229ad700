"""Reading log files, the state store, and exports."""
