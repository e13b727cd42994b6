"""DataFrame -> DataFrame operators. They are lazy unless their docstring says otherwise."""
