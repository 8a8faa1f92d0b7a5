"""Plans that combine operators: measures, clustering, and the registered queries."""
