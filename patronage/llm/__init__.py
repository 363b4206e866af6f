"""Training-data pipeline operators. Nothing else in the package imports this
subpackage; it imports only general helpers from the rest."""
