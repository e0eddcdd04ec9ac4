"""Plans: site rules, the crawl plan, and the registered queries."""
